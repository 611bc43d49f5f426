"""Table scans, saved-answer decoding, and the derived test corpus."""
