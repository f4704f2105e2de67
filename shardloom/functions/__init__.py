"""shardloom.functions"""
