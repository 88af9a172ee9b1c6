"""Plan builders around the search operator."""
