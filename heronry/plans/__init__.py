"""Rules and the plans composed of operators."""
