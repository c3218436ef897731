"""Spark jobs that survey how documents describe multi-step workflows."""
