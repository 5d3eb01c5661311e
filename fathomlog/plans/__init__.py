"""From the surface language to typed plain rules."""
