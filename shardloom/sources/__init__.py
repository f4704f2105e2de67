"""shardloom.sources"""
