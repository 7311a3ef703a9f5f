"""Plans: the batch pipeline and the dashboard bundle."""
