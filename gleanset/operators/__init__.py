"""Operators on points: encoders, statistics, sampling, noise, scoring, label quality, selection."""
