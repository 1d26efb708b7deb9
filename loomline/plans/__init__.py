"""Plans of loomline."""
