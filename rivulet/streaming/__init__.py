"""Re-making a plan as new data arrives."""
