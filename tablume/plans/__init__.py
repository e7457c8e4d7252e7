"""Compositions of operators: advice, analysis dispatch and the automatic report."""
