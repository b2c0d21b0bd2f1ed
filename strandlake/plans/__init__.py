"""strandlake.plans"""
