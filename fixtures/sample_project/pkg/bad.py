def broken(:
    pass
