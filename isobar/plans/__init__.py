"""Plans that depend on the data: which expressions serve which grids."""
