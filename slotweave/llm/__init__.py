"""Operators of a training-data pipeline: nearest-time matching, percentile sketches, texts. Optional; nothing else imports it."""
