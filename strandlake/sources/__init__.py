"""strandlake.sources"""
