"""Jobs composed of the operators; each is one lazy plan."""
