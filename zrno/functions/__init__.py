"""zrno.functions"""
