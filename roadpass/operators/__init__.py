"""DataFrame operators over the typed ``passes`` frame."""
