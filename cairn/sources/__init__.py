"""Where streams and tables of the engine come from."""
