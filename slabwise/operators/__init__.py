"""slabwise.operators"""
