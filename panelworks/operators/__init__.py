"""Set-based panel operators."""
