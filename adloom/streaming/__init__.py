"""adloom.streaming"""
