"""The three stages (discover, offload, purge) and configuration changes as DataFrame plans."""
