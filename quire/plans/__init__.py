"""Page-layout analytics: plans."""
