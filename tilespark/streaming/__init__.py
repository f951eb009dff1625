"""tilespark.streaming"""
