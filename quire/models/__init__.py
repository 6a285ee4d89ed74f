"""Networks as plain numpy, for where no framework is at hand."""
