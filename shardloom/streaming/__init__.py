"""shardloom.streaming"""
