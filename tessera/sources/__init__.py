"""Tables, grids and containers."""
