"""Asset-panel analytics on Spark: panels, returns, backtests and their summaries."""
