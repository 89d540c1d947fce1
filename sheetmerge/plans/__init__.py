"""Plans: the end-to-end job, sizing decisions and derived fixtures."""
