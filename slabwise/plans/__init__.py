"""slabwise.plans"""
