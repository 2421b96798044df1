"""zrno.operators"""
