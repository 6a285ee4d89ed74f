"""Page-layout analytics: sources."""
