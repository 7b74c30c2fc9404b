"""Reading exports, keeping the load log, writing tables."""
