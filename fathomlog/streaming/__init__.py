"""Programs over growing inputs: see ``fathomlog.streaming.growing``."""
