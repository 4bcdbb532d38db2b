"""functions of the credential-hygiene jobs."""
