"""Small vectorised helpers."""
