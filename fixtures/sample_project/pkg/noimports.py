def alone():
    return other()


def other():
    return 2
