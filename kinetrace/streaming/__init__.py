"""Online event detection."""
