"""zrno.streaming"""
