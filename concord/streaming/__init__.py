"""The compared workload is batch only: it has no unbounded source, watermark or state, so nothing is claimed here."""
