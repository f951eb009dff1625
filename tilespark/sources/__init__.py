"""tilespark.sources"""
