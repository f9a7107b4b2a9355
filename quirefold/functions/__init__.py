"""quirefold.functions"""
