"""streaming of the credential-hygiene jobs."""
