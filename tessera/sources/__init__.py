"""Readers and writers of the tabular, log, record and document inputs."""
