from tripleloom.cli import main

main()
