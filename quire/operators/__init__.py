"""Page-layout analytics: operators."""
