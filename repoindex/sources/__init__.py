"""Where tables come from and go to: file trees, JSON payloads, and the versioned index store."""
