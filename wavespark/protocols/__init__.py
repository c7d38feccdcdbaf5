"""Protocol decoders: scans over the edges of one bus, run by decode.decode in grouped Arrow tasks."""
