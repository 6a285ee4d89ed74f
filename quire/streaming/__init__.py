"""Page-layout analytics: streaming."""
