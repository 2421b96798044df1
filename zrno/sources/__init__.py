"""zrno.sources"""
