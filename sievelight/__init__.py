"""Sievelight: grouped label-audit analytics and corpus preparation on Spark."""
