"""Trajectory, instruction and corpus analytics on Spark."""
