"""Where events and raw logs come from, and the shapes results are given in."""
