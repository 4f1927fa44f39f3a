"""Cohort analytics over clinical event tables, expressed as Spark DataFrames.

Every operator takes DataFrames and column names and returns a lazy
DataFrame; Catalyst chooses the physical plan.  ``caseweave.plans`` holds the
few plan shapes that keep a hot key from landing in one task.
"""

__version__ = "0.1.0"
