"""Pure Column builders; nothing here reads, shuffles or runs Python on rows."""
