"""operators of the credential-hygiene jobs."""
