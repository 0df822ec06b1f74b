"""adloom.plans"""
