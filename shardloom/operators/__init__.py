"""shardloom.operators"""
