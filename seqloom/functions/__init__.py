"""Operations on values: monoids, order keys and random numbers."""
