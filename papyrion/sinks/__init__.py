"""Writers that turn rows back into documents."""
