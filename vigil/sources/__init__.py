"""sources of the credential-hygiene jobs."""
