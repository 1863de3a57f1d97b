"""Where data goes: lake tables and published results."""
