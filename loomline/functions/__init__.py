"""Functions of loomline."""
