"""Named queries over derived graphs."""
