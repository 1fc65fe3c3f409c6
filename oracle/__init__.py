"""The same questions as plain SQL, for the side-by-side check."""
