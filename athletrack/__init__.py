"""Athlete-tracking data at scale: detections, poses and timing records of many sessions as DataFrames."""
