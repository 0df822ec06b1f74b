"""adloom.sources"""
