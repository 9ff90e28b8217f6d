"""Operators over tables of bars, ticks, chains, trades and runs."""
