"""Driver-side mathematics: small arrays that operators take as literals or broadcast tables."""
