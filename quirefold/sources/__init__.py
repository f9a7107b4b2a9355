"""quirefold.sources"""
