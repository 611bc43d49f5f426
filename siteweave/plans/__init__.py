"""Whole runs: research, export, incremental, and the query catalogue."""
