"""quirefold.plans"""
