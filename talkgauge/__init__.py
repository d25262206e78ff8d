"""Talkgauge: analytics over evaluated conversations, as Spark DataFrame jobs.

Every function takes DataFrames (or a path plus a session) and returns a lazy
DataFrame.  Nothing in the package collects data to the driver.
"""
