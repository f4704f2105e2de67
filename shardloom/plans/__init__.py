"""shardloom.plans"""
