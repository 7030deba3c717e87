"""Runnable plans: the query catalogue over the standard tables and the three end-to-end cohort flows."""
