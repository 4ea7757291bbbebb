"""The SQL front door, plan rewrites and the capability report."""
