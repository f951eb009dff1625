"""tilespark.plans"""
