"""plans of the credential-hygiene jobs."""
