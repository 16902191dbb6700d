"""DataFrame operators over items, claims and edges."""
