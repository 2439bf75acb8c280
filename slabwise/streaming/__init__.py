"""slabwise.streaming"""
