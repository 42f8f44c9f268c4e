"""Speed-class model per camera from recent minutes of related cameras."""
