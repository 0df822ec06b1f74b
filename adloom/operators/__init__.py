"""adloom.operators"""
