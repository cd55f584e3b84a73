"""DataFrame operators; each works on batch tables, most on streams too."""
